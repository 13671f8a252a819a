"""Steps with declared inputs and outputs.

A step's ``transform`` maps frames to a frame and only extends their plans. The decorators say what it needs and makes;
needs are checked against specifications before the body runs, so a wrong pipeline fails without a job.
"""

from __future__ import annotations

import functools
import glob
import importlib
import importlib.metadata
import inspect
import re
import typing
import warnings
from collections.abc import Callable, Iterator
from pathlib import Path

from tessera import __version__
from tessera.frame import AnnotatedFrame
from tessera.model.spec import ColumnSpec, FrameSpec, Mode

MAIN = "df"
_PATTERN = re.compile(r"\{\{\s*(?:(\w+)\s*:\s*)?([\w.-]+)\s*\}\}")
Requirements = dict[str, dict | ColumnSpec]


def as_specs(requirements: Requirements, name: Callable[[str], str] = lambda n: n) -> FrameSpec:
    """Requirements as a specification, with names (patterns included) resolved."""
    made = []
    for key, body in requirements.items():
        if isinstance(body, ColumnSpec):
            made.append(body.but(name=name(key)))
        else:
            made.append(ColumnSpec(name=name(key), **body))
    return FrameSpec(made)


def describe(text: str):
    """Attach a description to a transform."""

    def decorate(f):
        f.description = text
        return f

    return decorate


def input(requirements: Requirements, label: str = MAIN):  # noqa: A001
    """Declare what the frame given for ``label`` must have; one declaration for each data source."""

    def decorate(f):
        declared = getattr(f, "inputs", {})
        if label in declared:
            raise KeyError(f"input: '{label}' is declared twice")

        @functools.wraps(f)
        def checked(self: Step, *frames: AnnotatedFrame, **named: AnnotatedFrame):
            given = bind(checked, frames, named)
            if label not in given:
                raise KeyError(f"input: no frame is given for '{label}'")
            lacking = as_specs(requirements, lambda n: self.get_name(n, label)).unfulfilled(given[label].spec)
            if lacking:
                raise RuntimeError(f"Input requirements are not fulfilled by '{label}' in {type(self).__name__}: {lacking}")
            return f(self, **given)

        checked.inputs = {label: requirements, **declared}
        checked.arguments = getattr(f, "arguments", None) or [p for p in inspect.signature(inspect.unwrap(f)).parameters if p != "self"]
        return checked

    return decorate


def bind(f, frames: tuple, named: dict) -> dict[str, AnnotatedFrame]:
    """Frames by label, whether they were given by position or by name."""
    return dict(zip(f.arguments, frames, strict=False)) | named


def output(requirements: Requirements):
    """Declare columns that the step makes. No input column of the main frame may disappear."""

    def decorate(f):
        hints = typing.get_type_hints(inspect.unwrap(f), include_extras=False) if inspect.unwrap(f).__annotations__ else {}
        if hints.get("return") is not AnnotatedFrame:
            raise RuntimeError(f"output: '{f.__qualname__}' must be annotated to return AnnotatedFrame")

        @functools.wraps(f)
        def checked(self: Step, *frames: AnnotatedFrame, **named: AnnotatedFrame) -> AnnotatedFrame:
            given = bind(checked, frames, named)
            main = given[checked.arguments[0]]
            before, spec = main.column_names, main.spec
            result = f(self, **given)
            if result is None:
                raise RuntimeError(f"output: {type(self).__name__} returned nothing; a return statement may be missing")
            if not isinstance(result, AnnotatedFrame):
                raise RuntimeError(f"output: {type(self).__name__} returned {type(result).__name__}, not an AnnotatedFrame")
            if lost := [c for c in before if c not in result.column_names]:
                raise RuntimeError(f"output: {type(self).__name__} lost the columns {lost}")
            declared = as_specs(requirements, self.get_name)
            if missing := [c.name for c in declared.columns if c.name not in result.column_names and not c.is_optional]:
                raise RuntimeError(f"output: {type(self).__name__} did not make the columns {missing}")
            present = FrameSpec([c for c in declared.columns if c.name in result.column_names])
            merged = result.spec.merge(spec.select([n for n in spec.column_names if n not in result.spec]))
            out = result._with(result.df, merged).updated(result.df, present)
            if self.eager_validation:
                out = out._with(out.df, _narrow_check(out, present))
            return out

        checked.output_requirements = requirements
        checked.inputs = getattr(f, "inputs", {})
        checked.arguments = getattr(f, "arguments", None) or [p for p in inspect.signature(inspect.unwrap(f)).parameters if p != "self"]
        return checked

    return decorate


def _narrow_check(frame: AnnotatedFrame, declared: FrameSpec) -> FrameSpec:
    from tessera import validation

    validation.apply(frame.df.select(*declared.column_names), declared, Mode.READONLY, strict_types=False)
    return frame.spec


def artifacts(patterns: dict[str, str | Path]):
    """Files (paths or globs under the pipeline's base directory) that must exist after the step."""

    def decorate(f):
        @functools.wraps(f)
        def checked(self: Step, *frames: AnnotatedFrame, **named: AnnotatedFrame):
            result = f(self, *frames, **named)
            for name, pattern in patterns.items():
                path = Path(pattern)
                where = str(path if path.is_absolute() else Path(self.base_dir) / path)
                if not path.is_absolute() and not glob.glob(where, recursive=True) or path.is_absolute() and not path.exists():
                    raise RuntimeError(f"artifacts: '{name}' of {type(self).__name__} is missing: {where}")
            return result

        checked.artifact_patterns = patterns
        checked.inputs, checked.arguments = getattr(f, "inputs", {}), getattr(f, "arguments", ["df"])
        checked.output_requirements = getattr(f, "output_requirements", {})
        return checked

    return decorate


class Step:
    """A transformer. Constructor parameters must be attributes of the same name: they are what is saved.

    ``mappings`` translate the step's own column names to those of the data, for each data source. A name that is mapped
    to another mapped name is followed; ``{{x}}_suffix`` and ``{{source:x}}`` are filled in with translated names.
    """

    eager_validation = False
    base_dir: str | Path = "."

    @property
    def mappings(self) -> dict[str, dict[str, str]]:
        return self.__dict__.setdefault("_mappings", {})

    def map_names(self, names: dict | None = None, source: str = MAIN) -> Step:
        """Add translations; a nested dict gives them by data source."""
        for key, value in (names or {}).items():
            if isinstance(value, dict):
                self.mappings.setdefault(key, {}).update(value)
            else:
                self.mappings.setdefault(source, {})[key] = value
        return self

    def get_name(self, name: str, source: str = MAIN) -> str:
        if _PATTERN.search(name):
            filled = _PATTERN.sub(lambda m: self.get_name(m[2], m[1] or source), name)
            return self.mappings.get(source, {}).get(name, filled)
        seen, known = {name}, self.mappings.get(source, {})
        while name in known and known[name] not in seen:
            name = known[name]
            seen.add(name)
        return name

    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        raise NotImplementedError

    # -- declarations --------------------------------------------------------------------------------------------------

    @property
    def sources(self) -> list[str]:
        return list(getattr(self.transform, "arguments", [MAIN]))

    def input_spec(self, source: str = MAIN) -> FrameSpec:
        return as_specs(getattr(self.transform, "inputs", {}).get(source, {}), lambda n: self.get_name(n, source))

    def output_spec(self) -> FrameSpec:
        return as_specs(getattr(self.transform, "output_requirements", {}), self.get_name)

    @property
    def description(self) -> str:
        return getattr(self.transform, "description", "")

    def text(self) -> str:
        lines = [f"{type(self).__name__}: {self.description}"]
        lines += [f"  in {s}: {', '.join(self.input_spec(s).column_names) or '-'}" for s in self.sources]
        return "\n".join([*lines, f"  out: {', '.join(self.output_spec().column_names) or '-'}"])

    # -- persistence ---------------------------------------------------------------------------------------------------

    def parameters(self) -> dict:
        out = {}
        for name in list(inspect.signature(type(self).__init__).parameters)[1:] if type(self).__init__ is not object.__init__ else []:
            if not hasattr(self, name):
                raise AttributeError(f"{type(self).__name__}: parameter '{name}' must be an attribute to be saved")
            out[name] = getattr(self, name)
        return out

    def to_dict(self) -> dict:
        return {
            "module_name": type(self).__module__,
            "class_name": type(self).__name__,
            "parameters": {k: plain(v) for k, v in self.parameters().items()},
            "name_mappings": {k: dict(v) for k, v in self.mappings.items()},
            "requires": requirement(type(self).__module__),
        }

    @staticmethod
    def from_dict(data: dict) -> Step:
        from tessera.plans.plugins import find

        check_requirement(data.get("requires"))
        kind = find(data["class_name"], data["module_name"])
        return kind(**(data.get("parameters") or {})).map_names(data.get("name_mappings"))

    def __deepcopy__(self, memo: dict) -> Step:
        """Mappings are copied; parameters, data frames among them, are shared."""
        made = object.__new__(type(self))
        made.__dict__.update(self.__dict__, _mappings={k: dict(v) for k, v in self.mappings.items()})
        return made

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.to_dict() == other.to_dict()

    __hash__ = object.__hash__


def plain(value: object) -> object:
    """A parameter as YAML can hold it."""
    if isinstance(value, Path):
        return str(value)
    if hasattr(value, "value") and not isinstance(value, (int, str, float)):
        return value.value
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "to_dict"):
        return value.to_dict()
    return value if isinstance(value, (int, float, bool, type(None))) else str(value)


def requirement(module: str) -> str | None:
    """The distribution that a module comes from, with its version."""
    top = module.partition(".")[0]
    if top == "tessera":
        return f"tessera=={__version__}"
    names = importlib.metadata.packages_distributions().get(top)
    return f"{names[0]}=={importlib.metadata.version(names[0])}" if names else None


def check_requirement(text: str | None) -> None:
    """Warn where another version is installed than the one saved (a bare version is a minimum); raise where none is."""
    if not text:
        return
    name, how, wanted = re.fullmatch(r"\s*([\w.-]+?)\s*(?:(==|>=)?\s*([\d][\w.]*))?\s*", text).groups()
    try:
        have = __version__ if name == "tessera" else importlib.metadata.version(name)
    except importlib.metadata.PackageNotFoundError:
        raise RuntimeError(f"'{text}' is needed but not installed: pip install '{name}{(how or '>=') + wanted if wanted else ''}'") from None
    number = lambda v: [int(x) if x.isdigit() else 0 for x in v.split(".")]
    if wanted and (have != wanted if how == "==" else number(have) < number(wanted)):
        warnings.warn(f"'{text}' was saved, version {have} is installed", stacklevel=2)


def subclasses(kind: type = Step) -> Iterator[type]:
    for sub in kind.__subclasses__():
        yield sub
        yield from subclasses(sub)


def load_class(module: str, name: str) -> type:
    return getattr(importlib.import_module(module), name)
