"""Physical building blocks (global order, order statistics) and the end-to-end flows built on them."""
