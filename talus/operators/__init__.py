"""DataFrame operators on clouds: (pid, x, y, z) and what is made from them."""
