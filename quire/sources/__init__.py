"""File sniffing and decoding into blocks and cells."""
