"""Drive-test analytics as Spark jobs: DataFrame in, DataFrame out."""

from drivescope.session import session

__all__ = ["session"]
