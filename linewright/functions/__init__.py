"""Column functions: text, vectors and colours. None of them runs Python on rows."""
