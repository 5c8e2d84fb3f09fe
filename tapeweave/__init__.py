"""Market-panel analytics as Spark DataFrame operators over tables keyed by ticker and date."""
