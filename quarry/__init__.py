"""Search, retrieval and document processing over saved web content, as Spark jobs."""
