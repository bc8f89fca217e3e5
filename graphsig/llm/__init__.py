"""Training-data operators over documents, pages, URLs and conversations, as Spark jobs."""
