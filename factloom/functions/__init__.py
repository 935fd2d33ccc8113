"""Column functions and the word lists that they take."""
