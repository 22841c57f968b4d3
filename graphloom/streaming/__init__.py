"""Extensions over streams."""
