"""Training-data operators on text corpora; nothing else in the library imports this subpackage."""
