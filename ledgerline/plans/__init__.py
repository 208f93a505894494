"""Named queries over whole tables, with the SQL they are compared with."""
