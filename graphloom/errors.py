"""Errors that operators raise."""


class GraphError(Exception):
    """Base of all."""


class GraphConstructionError(GraphError):
    pass


class InvalidParameter(GraphError, ValueError):
    pass


class NodeNotFound(GraphError, KeyError):
    pass


class EdgeNotFound(GraphError, KeyError):
    pass


class EmptyGraph(GraphError):
    pass


class QueryParseError(GraphError, ValueError):
    pass


class ComputationError(GraphError):
    pass


class Unsupported(GraphError, NotImplementedError):
    pass


def check(condition: bool, message: str) -> None:
    if not condition:
        raise InvalidParameter(message)


def check_number(name: str, value, low=None, high=None, above=None) -> None:
    check(isinstance(value, (int, float)) and not isinstance(value, bool), f"{name} must be a number, got {value!r}")
    check(low is None or value >= low, f"{name} must be at least {low}")
    check(high is None or value <= high, f"{name} must be at most {high}")
    check(above is None or value > above, f"{name} must be above {above}")
