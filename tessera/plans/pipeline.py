"""Pipelines: graphs of steps, checked before any job, run as one plan, saved as YAML."""

from __future__ import annotations

import copy
import time
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera import __version__, validation
from tessera.frame import AnnotatedFrame
from tessera.model.spec import ColumnSpec, FrameSpec, Mode
from tessera.plans.step import MAIN, Step, output

SUFFIX = ".tessera.ppl"


@dataclass
class Node:
    """A step (or the data source that it stands for) and where each of its inputs comes from."""

    name: str
    step: Step | None = None
    slots: dict[str, str] = field(default_factory=dict)


class Graph:
    """Directed graph whose edges know the slot of the step that they feed."""

    def __init__(self) -> None:
        self.nodes: dict[str, Node] = {MAIN: Node(MAIN)}

    def add(self, node: Node) -> Node:
        if node.name in self.nodes:
            raise ValueError(f"Graph: '{node.name}' is there already")
        for source in node.slots.values():
            if source not in self.nodes:
                raise ValueError(f"Graph: '{node.name}' reads '{source}', which is not there")
        self.nodes[node.name] = node
        return node

    def order(self) -> list[Node]:
        """Topological order; names of nodes decide nothing."""
        done, out = set(), []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"Graph: a cycle through '{name}'")
            if name not in done:
                for source in self.nodes[name].slots.values():
                    visit(source, (*above, name))
                done.add(name)
                out.append(self.nodes[name])

        for name in self.nodes:
            visit(name, ())
        return out

    @property
    def last(self) -> Node:
        read = {s for n in self.nodes.values() for s in n.slots.values()}
        ends = [n for n in self.nodes.values() if n.name not in read and n.step is not None]
        if len(ends) > 1:
            raise ValueError(f"Graph: several ends: {[n.name for n in ends]}")
        return ends[0] if ends else self.nodes[MAIN]

    def to_dict(self) -> dict:
        nodes = [{"name": n.name, **({"step": n.step.to_dict()} if n.step else {})} for n in self.nodes.values()]
        edges = [{"from": s, "to": n.name, "slot": slot} for n in self.nodes.values() for slot, s in n.slots.items()]
        return {"nodes": nodes, "edges": edges}

    @staticmethod
    def from_dict(data: dict) -> Graph:
        graph = Graph()
        slots: dict[str, dict[str, str]] = {}
        for e in data["edges"]:
            slots.setdefault(e["to"], {})[e["slot"]] = e["from"]
        for n in data["nodes"]:
            if n["name"] != MAIN:
                step = n.get("step")
                made = None if step is None else Pipeline.from_dict(step["pipeline"]) if "pipeline" in step else Step.from_dict(step)
                graph.nodes[n["name"]] = Node(n["name"], made, slots.get(n["name"], {}))
        graph.order()
        return graph

    def text(self) -> str:
        show = lambda n: f"{n.name} <- {', '.join(f'{k}={v}' for k, v in n.slots.items())}\n  {n.step.text()}" if n.step else f"{n.name} (data)"
        return "\n".join(show(n).replace("\n", "\n  ") for n in self.order())


@dataclass
class StepStats:
    """Rows of a step's result (known once an action has run), and seconds spent on building its plan."""

    name: str
    seconds: float
    observed: Observation | None = None

    @property
    def rows(self) -> int | None:
        return self.observed.get["rows"] if self.observed is not None else None


def _redeclared(old: ColumnSpec, declared: ColumnSpec) -> ColumnSpec:
    """What is known of a column after a step that declares it: declared fields win, a range is declared or gone."""
    said = {k: v for k in ("description", "category", "representation_type", "missing_value", "precision", "unit") if (v := getattr(declared, k)) is not None}
    return old.but(**said, value_range=declared.value_range, value_stats=declared.value_stats, value_meanings=dict(declared.value_meanings))


class Pipeline(Step):
    """A named graph of steps; itself a step.

    ``validation``: ``deferred`` checks the declared outputs that are left in the result with one aggregation, ``eager``
    checks after every step, ``off`` leaves checking to the caller. ``observe`` counts rows of every step while the
    caller's own action runs.
    """

    def __init__(self, name: str = "pipeline", description: str = "", base_dir: str | Path = ".", validation: str = "deferred", observe: bool = False, final_stats: bool = False):
        if validation not in ("deferred", "eager", "off"):
            raise ValueError(f"Pipeline: validation '{validation}' is not known")
        self.name, self.title, self.base_dir = name, description, str(base_dir)
        self.validation, self.observe, self.final_stats = validation, observe, final_stats
        self.graph, self.stats = Graph(), []
        self.validation_output_spec: FrameSpec | None = None

    def __deepcopy__(self, memo: dict) -> Pipeline:
        made = super().__deepcopy__(memo)
        made.graph, made.stats = copy.deepcopy(self.graph, memo), []
        return made

    # -- building ------------------------------------------------------------------------------------------------------

    @property
    def description(self) -> str:
        return self.title

    @property
    def steps(self) -> list[tuple[str, Step]]:
        return [(n.name, n.step) for n in self.graph.order() if n.step is not None]

    def add(self, name: str, step: Step, name_mappings: dict | None = None) -> Pipeline:
        """Append a step that reads the last one's result."""
        if len(step.sources) > 1:
            raise ValueError(f"Pipeline: '{name}' has several inputs; use join")
        step.map_names(name_mappings)
        self.graph.add(Node(name, step, {step.sources[0]: self.graph.last.name}))
        return self

    def join(self, name: str, operator: Step, data_source: str | Pipeline | None = None, name_mappings: dict | None = None) -> Pipeline:
        """Append a step of two inputs; the second is data given to ``transform`` under the slot's name, or a pipeline over it."""
        main, *others = operator.sources
        if len(others) != 1:
            raise ValueError(f"Pipeline: '{name}' needs exactly two inputs")
        operator.map_names(name_mappings)
        before = self.graph.last.name
        source = data_source if isinstance(data_source, str) else others[0]
        if source not in self.graph.nodes:
            self.graph.add(Node(source))
        if isinstance(data_source, Pipeline):
            self.graph.add(Node(f"{source}/{data_source.name}", data_source, {MAIN: source}))
            source = f"{source}/{data_source.name}"
        self.graph.add(Node(name, operator, {main: before, others[0]: source}))
        return self

    @property
    def sources(self) -> list[str]:
        return [n.name for n in self.graph.nodes.values() if n.step is None]

    def input_spec(self, source: str = MAIN) -> FrameSpec:
        first = next((n for n in self.graph.order() if n.step and source in n.slots.values()), None)
        return first.step.input_spec(next(k for k, v in first.slots.items() if v == source)) if first else FrameSpec()

    def output_spec(self) -> FrameSpec:
        spec = FrameSpec()
        for _, step in self.steps:
            spec = spec.with_columns(*step.output_spec().columns)
        return spec

    # -- checking ------------------------------------------------------------------------------------------------------

    def check(self, given: dict[str, FrameSpec]) -> FrameSpec:
        """Propagate specifications through the graph without touching data; raises where an input is not met."""
        known: dict[str, FrameSpec] = {}
        for node in self.graph.order():
            if node.step is None:
                if node.name not in given:
                    raise KeyError(f"Pipeline: no data is given for '{node.name}'")
                known[node.name] = given[node.name]
                continue
            for slot, source in node.slots.items():
                if lacking := node.step.input_spec(slot).unfulfilled(known[source]):
                    raise RuntimeError(f"Input requirements are not fulfilled by '{slot}' in step '{node.name}': {lacking}")
            main = known[node.slots[node.step.sources[0]]]
            if isinstance(node.step, Pipeline):
                known[node.name] = node.step.check({MAIN: main})
            else:
                new = [c if c.name not in main else _redeclared(main[c.name], c) for c in node.step.output_spec().columns]
                known[node.name] = main.with_columns(*new)
        self.validation_output_spec = known[self.graph.last.name]
        return self.validation_output_spec

    def prepare(self, df: AnnotatedFrame, validate: bool = False, **others: AnnotatedFrame | str) -> Pipeline:
        """A copy that fits the data: frames by keyword are secondary sources, strings redirect a mapping's target.

        ``validate``: also check the input frames' data against their specifications, a job each.
        """
        frames = {MAIN: df} | {k: v for k, v in others.items() if isinstance(v, AnnotatedFrame)}
        overlay = {k: v for k, v in others.items() if isinstance(v, str)}
        own = copy.deepcopy(self)
        for _, step in own.steps:
            for mapping in step.mappings.values():
                for key, target in mapping.items():
                    mapping[key] = overlay.get(target, target)
        for name, frame in frames.items():
            if not isinstance(frame, AnnotatedFrame):
                raise TypeError(f"Pipeline: '{name}' must be an AnnotatedFrame, got {type(frame).__name__}")
            if validate:
                frame.validate(Mode.READONLY, strict_types=False)
        own.check({k: f.spec for k, f in frames.items()})
        return own

    # -- running -------------------------------------------------------------------------------------------------------

    def transform(self, df: AnnotatedFrame, verbose: bool = False, **others: AnnotatedFrame) -> AnnotatedFrame:
        """Run all steps as one lazy plan.

        ``verbose`` shows a row of every step's result. Each is a job of its own, and an observation would end with the first
        of them, so rows are not counted then.
        """
        own = self.prepare(df, **others)
        frames: dict[str, AnnotatedFrame] = {MAIN: df} | {k: v for k, v in others.items() if isinstance(v, AnnotatedFrame)}
        self.stats = []
        for number, node in enumerate(own.graph.order()):
            if node.step is None:
                continue
            began = time.perf_counter()
            node.step.eager_validation, node.step.base_dir = self.validation == "eager", self.base_dir
            inputs = {slot: frames[source] for slot, source in node.slots.items()}
            try:
                result = node.step.transform(**inputs)
            except Exception as e:
                raise RuntimeError(f"Pipeline '{self.name}': step {number} '{node.name}' ({type(node.step).__name__}): {e}") from e
            if verbose:
                print(f"{self.name}: {node.name}")
                result.df.show(1)
            observed = None
            if self.observe and not verbose:
                observed = Observation(f"{self.name}-{node.name}")
                result = result._with(result.df.observe(observed, F.count(F.lit(1)).alias("rows")), result.spec)
            frames[node.name] = result
            self.stats.append(StepStats(node.name, time.perf_counter() - began, observed))
        result = frames[own.graph.last.name]
        if self.validation == "deferred":
            declared = own.output_spec()
            kept = FrameSpec([c for c in declared.columns if c.name in result.column_names])
            if any(c.value_range is not None for c in kept.columns):
                validation.apply(result.df.select(*kept.column_names), kept, Mode.READONLY, strict_types=False)
        if self.final_stats:
            result = result.validate(Mode.UPDATE_METADATA)
        return result

    transform.arguments = [MAIN]

    # -- persistence ---------------------------------------------------------------------------------------------------

    def to_dict(self) -> dict:
        own = {"name": self.name, "description": self.title, "meta": {"version": __version__}, "base_dir": self.base_dir, "validation": self.validation}
        graph = self.graph.to_dict()
        for node in graph["nodes"]:
            step = self.graph.nodes[node["name"]].step
            if isinstance(step, Pipeline):
                node["step"] = {"pipeline": step.to_dict()}
        return {**own, **graph}

    @staticmethod
    def from_dict(data: dict) -> Pipeline:
        made = Pipeline(data["name"], data.get("description", ""), data.get("base_dir", "."), data.get("validation", "deferred"))
        made.graph = Graph.from_dict(data)
        return made

    def save(self, folder: str | Path) -> Path:
        path = Path(folder) / f"{self.name}{SUFFIX}"
        path.write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))
        return path

    @staticmethod
    def load(path: str | Path, name: str = "*") -> Pipeline:
        """From a file, or from the single match of ``name`` in a folder."""
        path = Path(path)
        if path.is_dir():
            found = sorted(path.glob(f"{name}{SUFFIX}"))
            if len(found) != 1:
                raise FileNotFoundError(f"Pipeline: {len(found)} matches for '{name}{SUFFIX}' in {path}: {[p.name for p in found]}")
            path = found[0]
        if not path.exists():
            raise FileNotFoundError(f"Pipeline: no file {path}")
        return Pipeline.from_dict(yaml.safe_load(path.read_text()))

    def save_state(self, df: AnnotatedFrame, folder: str | Path) -> Path:
        """The data as it stands and the pipeline: plans themselves cannot be stored, their results can."""
        path = Path(folder)
        path.mkdir(parents=True, exist_ok=True)
        df.annotated.write.mode("overwrite").parquet(str(path / f"{self.name}.state"))
        self.save(path)
        return path

    @staticmethod
    def load_state(spark, folder: str | Path, name: str = "*") -> tuple[Pipeline, AnnotatedFrame]:
        made = Pipeline.load(folder, name)
        data = spark.read.parquet(str(Path(folder) / f"{made.name}.state"))
        return made, AnnotatedFrame(data, FrameSpec.from_schema(data.schema), Mode.IGNORE)

    def text(self) -> str:
        return f"{self.name}: {self.title}\n{self.graph.text()}"


__all__ = ["Graph", "Node", "Pipeline", "StepStats", "output"]
