"""lodestone: review-theme analytics and corpus preparation as Spark DataFrame operators."""

from lodestone.session import build_session, durable

__all__ = ["build_session", "durable"]
