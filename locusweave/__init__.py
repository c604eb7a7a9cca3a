"""Gene-neighbourhood analytics on PySpark: similarity joins, chaining, clustering,
architecture, explorer and evaluation queries as DataFrame transformations."""
