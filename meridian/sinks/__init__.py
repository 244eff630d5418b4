"""Tables and files that are written: changes of partitioned tables, exports with manifests."""
