"""Log operators on streams; each gives what its batch form gives once the input has ended."""
