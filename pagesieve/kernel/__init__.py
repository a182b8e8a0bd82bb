"""Work within one document: pure Python without any Spark object, called once per page."""
