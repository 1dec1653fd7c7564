"""What can be wrong with a query; every message says what and where."""


class QueryError(Exception):
    """Base of all errors about a query."""


class SyntaxProblem(QueryError):
    """The text is no query of the dialect."""


class LimitProblem(QueryError):
    """The text is beyond a size limit."""


class BindingProblem(QueryError):
    """A name, type or grouping doesn't fit the data."""


class FunctionProblem(QueryError):
    """An unknown function or a wrong number or kind of arguments."""


class SourceProblem(QueryError):
    """A table can't be found or read."""
