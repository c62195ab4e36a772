"""lawlake: Spark-native analytics over structured legislation."""
