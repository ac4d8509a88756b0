"""Where the six tables come from."""
