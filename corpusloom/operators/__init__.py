"""DataFrame -> DataFrame operators over documents, blocks, lines, links and runs."""
