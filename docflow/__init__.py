"""Document correlation and process knowledge on Spark DataFrames."""

from docflow.config import Params
from docflow.session import get_session

__all__ = ["Params", "get_session"]
