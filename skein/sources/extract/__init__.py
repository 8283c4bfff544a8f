"""Facts from source files: an island parser that knows declarations and calls, not whole grammars."""
