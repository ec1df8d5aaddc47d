"""What is known of one word at a time: plain Python, run over Arrow batches where no built-in function will do."""
