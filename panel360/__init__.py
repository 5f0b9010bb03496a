"""Patient and member 360 analytics as composable Spark DataFrame operators."""

from panel360.session import local_session

__all__ = ["local_session"]
