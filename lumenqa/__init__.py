"""lumenqa: grounded question-answering analytics as DataFrame plans."""
