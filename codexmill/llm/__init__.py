"""Training-data operators: ten building blocks for preparing a text corpus at scale."""
