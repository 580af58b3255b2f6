"""Three-way merges of contents: (path, base, ours, theirs) to a merged content or conflicts."""
