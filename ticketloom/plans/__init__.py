"""The lazily built relation graph and the size checks that pick its plans."""
