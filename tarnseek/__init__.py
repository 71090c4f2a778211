"""Search and analytics over keyed JSON records, on Spark."""

from tarnseek.errors import TarnseekError
from tarnseek.functions.analyzers import Analyzer, Pipeline, register_analyzer
from tarnseek.operators.clauses import (
    Between,
    Compare,
    Equals,
    Everything,
    HasField,
    Like,
    MatchAll,
    MatchAny,
    Phrase,
)
from tarnseek.operators.view import TableView
from tarnseek.plans.catalog import Catalog
from tarnseek.plans.search import SearchResult, search_view
from tarnseek.schema import Field, Kind, RecordSource, TableSpec

__all__ = [
    "Analyzer",
    "Between",
    "Catalog",
    "Compare",
    "Equals",
    "Everything",
    "Field",
    "HasField",
    "Kind",
    "Like",
    "MatchAll",
    "MatchAny",
    "Phrase",
    "Pipeline",
    "RecordSource",
    "SearchResult",
    "TableSpec",
    "TableView",
    "TarnseekError",
    "register_analyzer",
    "search_view",
]
