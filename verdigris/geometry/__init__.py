"""Kernels for shapes that aren't boxes, in numpy: WKB, measures, predicates, overlay, buffers, projection, contours."""
