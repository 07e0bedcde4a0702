"""Plan helpers: materialisation, checked broadcasts, ranked windows."""
