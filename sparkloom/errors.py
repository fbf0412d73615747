"""Errors of the engine."""


class GraphError(Exception):
    """Base of all errors that the engine raises itself."""


class CypherSyntaxError(GraphError):
    """A statement that does not parse; ``position`` is a character offset."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at position {position}")
        self.position = position


class CypherTypeError(GraphError):
    """A statement whose names or types do not fit together."""


class NodeNotFound(GraphError):
    pass


class EdgeNotFound(GraphError):
    pass


class NodeHasEdges(GraphError):
    """A plain DELETE of a node that still has edges."""


class ItemNotFound(GraphError):
    pass


class IndexExists(GraphError):
    pass


class IndexNotFound(GraphError):
    pass


class VectorValidation(GraphError):
    pass
