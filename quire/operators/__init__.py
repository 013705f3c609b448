"""DataFrame-to-DataFrame operators over documents, blocks, cells and text."""
