"""Column functions: text in, text, tokens or flags out.  None of them uses Python on executors."""
