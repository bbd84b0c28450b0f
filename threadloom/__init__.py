"""threadloom: chat-history preparation as Spark DataFrame transformations."""

from threadloom.config import ChatConfig

__all__ = ["ChatConfig"]
