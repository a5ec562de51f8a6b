"""Column functions: everything here returns a Spark ``Column`` or a literal for one."""
