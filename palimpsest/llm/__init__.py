"""Training-data operators: matching, tokenising, formatting, extraction and filtering at corpus scale."""
