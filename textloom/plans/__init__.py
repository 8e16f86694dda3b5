"""Named queries over the project's tables, with their SQL where SQL can say the same."""
