"""Query plans over the driver's tables, with their SQL, and lineage cuts for iterative ones."""
