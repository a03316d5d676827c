"""Graph algorithms over two frames: vertices (id, ...) and edges (src, dst, ...)."""
