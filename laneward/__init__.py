"""laneward: supply-chain risk analytics over tables and streams, on Spark."""
