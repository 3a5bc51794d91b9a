"""Training-data operators over corpora of documents. Nothing outside this folder imports it."""
