"""Feed analytics for a question-only micro-blog, as Spark DataFrame jobs."""

from agora.schema import Tables
from agora.session import local_session

__all__ = ["Tables", "local_session"]
