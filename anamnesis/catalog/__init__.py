"""Named queries over the stored tables, each with SQL that gives the same rows."""
