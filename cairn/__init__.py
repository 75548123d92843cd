"""cairn: dataset-integrity, evaluation and corpus analytics expressed as Spark DataFrame jobs."""
