"""newsdigest: a Spark-native news monitoring and digest engine."""

from .config import Config, latin_config

__all__ = ["Config", "latin_config"]
