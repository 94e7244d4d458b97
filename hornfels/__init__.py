"""hornfels: a PySpark-native deductive analytics engine."""
