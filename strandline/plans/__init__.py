"""SQL over a frame, and the registered queries."""
