"""Road-event analytics as Spark jobs: corridors, panels, scores, rankings and streams."""
