"""Files and tables that the engine reads and writes."""
