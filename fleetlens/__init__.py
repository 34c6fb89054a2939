"""Device-fleet telemetry analytics built from Spark DataFrame operators."""

__version__ = "0.1.0"
