"""Python, by its own grammar."""

from __future__ import annotations

import ast

from quarry.parsers import Call, Chunk, Import, Parsed


def parse(text: str) -> Parsed:
    """A text that is no valid Python gives nothing."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Parsed()
    visitor = _Visitor(text)
    visitor.run(tree)
    return visitor.out


class _Visitor:
    def __init__(self, text: str):
        self.text, self.lines, self.out = text, text.split("\n"), Parsed()

    def run(self, tree: ast.Module) -> None:
        stack: list[tuple[ast.AST, str | None, bool, Chunk | None]] = [(tree, None, False, None)]
        while stack:
            node, parent, in_class, owner = stack.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                # a decorated definition is not a direct child of the class body
                owner = self._chunk(node, "method" if in_class and not node.decorator_list else "function", parent)
                for d in node.decorator_list:
                    stack.append((d, parent, False, None))
                children = [c for c in ast.iter_child_nodes(node) if c not in node.decorator_list]
                stack += [(c, parent, False, owner) for c in reversed(children)]
                continue
            if isinstance(node, ast.ClassDef):
                self._chunk(node, "class", parent)
                stack += [(c, node.name, c in node.body, None) for c in reversed(list(ast.iter_child_nodes(node)))]
                continue
            if isinstance(node, ast.Call) and (call := self._call(node)):
                self.out.calls.append(call)
                if owner is not None:
                    owner.calls.append(call)
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                self._imports(node)
            stack += [(c, parent, False, owner) for c in reversed(list(ast.iter_child_nodes(node)))]

    def _chunk(self, node, kind: str, parent: str | None) -> Chunk:
        first = node.lineno
        top = first
        while top > 1:  # comments above, with nothing but white space between
            above = self.lines[top - 2].strip()
            if not above.startswith("#") and above:
                break
            top -= 1
        while top < first and not self.lines[top - 1].strip():
            top += 1
        body = ast.get_source_segment(self.text, node) or ""
        if top < first:
            head = "\n".join(self.lines[top - 1 : first - 1]).lstrip()
            body = head + "\n" + self.lines[first - 1][: node.col_offset] + body
        chunk = Chunk(node.name, kind, top, node.end_lineno or first, body, parent)
        self.out.chunks.append(chunk)
        return chunk

    def _call(self, node: ast.Call) -> Call | None:
        line, column = node.lineno, node.col_offset + 1
        if isinstance(node.func, ast.Name):
            return Call(node.func.id, line, column, False, None)
        if isinstance(node.func, ast.Attribute):
            return Call(node.func.attr, line, column, True, ast.get_source_segment(self.text, node.func.value))
        return None

    def _imports(self, node: ast.Import | ast.ImportFrom) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                self.out.imports.append(Import(a.name, None, a.asname or a.name.split(".")[0]))
            return
        source = "." * node.level + (node.module or "")
        for a in node.names:
            self.out.imports.append(Import(source, a.name, a.asname))
