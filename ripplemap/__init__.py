"""Change-impact and lineage-coverage analytics as Spark jobs over tables."""
