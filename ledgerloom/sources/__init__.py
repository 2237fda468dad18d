"""Reading and writing: folders of documents, records beside them, and the tables of a workspace."""
