"""Training-data operators over text, conversation, URL and embedding tables."""
