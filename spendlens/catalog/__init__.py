"""Named queries over the sample feeds and the SQL that checks them."""
