"""Column functions and small row helpers over the text of acts."""
