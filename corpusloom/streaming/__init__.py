"""The event log as a stream."""
from .events import *  # noqa: F401,F403
