"""Spark jobs over fleets of source trees, flowcharts, change sets and documents."""
