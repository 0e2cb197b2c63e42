"""A model of the syntax features of Python: each from the tree itself."""

import ast
from collections import Counter

import numpy as np

from codescope.functions.ast33 import NAMES, NESTING

DECISIONS = (ast.If, ast.For, ast.While, ast.And, ast.Or, ast.ExceptHandler, ast.With, ast.IfExp, ast.BoolOp)
BRANCHES = (ast.If, ast.For, ast.While, ast.With)


class Flat:
    """A tree as a table in preorder: nodes, depth, nesting and the end of each subtree, so that what a node holds is a slice."""

    def __init__(self, tree: ast.AST):
        self.nodes, self.depth, self.nested, self.end = [], [], [], []
        stack = [(tree, 0, 0)]
        while stack:
            node, d, n = stack.pop()
            if node is None:  # the subtree that began at d ends
                self.end[d] = len(self.nodes)
                continue
            stack.append((None, len(self.nodes), 0))
            self.nodes.append(node)
            self.depth.append(d)
            self.nested.append(n)
            self.end.append(0)
            stack += [(c, d + 1, n + isinstance(c, NESTING)) for c in reversed(list(ast.iter_child_nodes(node)))]

    def at(self, kind) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if isinstance(n, kind)]

    def inside(self, i: int, kind) -> int:
        return sum(isinstance(n, kind) for n in self.nodes[i : self.end[i]])


def python_features(code: str) -> list[float]:
    """In order of NAMES; zeros where the text is no Python."""
    try:
        f = Flat(ast.parse(code))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [0.0] * len(NAMES)
    avg = lambda xs: float(np.mean(xs)) if len(xs) else 0.0
    share = lambda a, b: a / b if b else 0.0
    n, depth = len(f.nodes), np.array(f.depth)
    kinds = np.array(list(Counter(type(x).__name__ for x in f.nodes).values()), float)
    functions, classes, tries = f.at(ast.FunctionDef), f.at(ast.ClassDef), f.at(ast.Try)
    defs = [f.nodes[i] for i in functions]
    arguments = [a for d in defs for a in d.args.args]
    docs = [s for i in functions + classes if (s := ast.get_docstring(f.nodes[i]))]
    handlers = [f.nodes[i] for i in f.at(ast.ExceptHandler)]
    names = [f.nodes[i].id for i in f.at(ast.Name)]
    snake = sum("_" in x and x.islower() for x in names)
    camel = sum("_" not in x and any(map(str.isupper, x)) for x in names)
    imports = [f.nodes[i] for i in f.at((ast.Import, ast.ImportFrom))]
    modules = {a.name for x in imports if isinstance(x, ast.Import) for a in x.names} | {x.module for x in imports if isinstance(x, ast.ImportFrom) and x.module}
    lengths, params = [d.end_lineno - d.lineno + 1 for d in defs], [len(d.args.args) for d in defs]
    lines = code.split("\n")
    out = {
        "max_depth": depth.max(), "avg_depth": depth.mean(), "depth_std": depth.std(), "max_breadth": np.bincount(depth).max(), "tree_balance": share(depth.mean(), depth.max()),
        "node_entropy": -(kinds / n * np.log2(kinds / n)).sum(), "unique_node_ratio": len(kinds) / n, "total_nodes": n, "if_count": len(f.at(ast.If)), "loop_count": len(f.at((ast.For, ast.While))), "try_count": len(tries),
        "cyclomatic_complexity": 1 + len(f.at(DECISIONS)), "nesting_depth": max(f.nested), "num_functions": len(defs), "avg_function_length": avg(lengths), "max_function_length": max(lengths, default=0),
        "avg_function_params": avg(params), "max_function_params": max(params, default=0), "avg_function_complexity": avg([f.inside(i, BRANCHES) for i in functions]),
        "num_classes": len(classes), "avg_methods_per_class": avg([f.inside(i, ast.FunctionDef) for i in classes]), "inheritance_depth": max((len(f.nodes[i].bases) for i in classes), default=0),
        "docstring_ratio": share(len(docs), len(functions) + len(classes)), "comment_density": sum(x.strip().startswith("#") for x in lines) / len(lines), "avg_docstring_length": avg([len(x) for x in docs]),
        "type_hint_ratio": share(sum(a.annotation is not None for a in arguments), len(arguments)), "return_annotation_ratio": share(sum(d.returns is not None for d in defs), len(defs)),
        "exception_specificity": share(sum(h.type is not None for h in handlers), len(handlers)) if handlers else 0.5, "try_coverage": sum(f.end[i] - i for i in tries) / n,
        "naming_consistency": share(max(snake, camel), len(names)), "avg_identifier_length": avg([len(x) for x in names]), "import_count": len(imports), "import_diversity": share(len(modules), len(imports)),
    }
    return [float(out[k]) for k in NAMES]
