"""quillspark: text analytics, retrieval and corpus preparation as Spark DataFrame plans."""
