"""linkloom: link-graph analytics and text-table processing as Spark plans."""
