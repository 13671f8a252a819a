"""Steps from elsewhere: installed entry points and folders of Python files named by an environment variable."""

from __future__ import annotations

import importlib.metadata
import importlib.util
import os
import sys
import warnings
from pathlib import Path

from tessera.plans.step import Step, load_class, subclasses

GROUP = "tessera.steps"
PATH_VARIABLE = "TESSERA_PLUGIN_PATH"

_found: dict[str, tuple[str, type]] | None = None


def _is_step(kind: object) -> bool:
    return isinstance(kind, type) and issubclass(kind, Step) and kind is not Step


def _from_files() -> list[tuple[str, str, type]]:
    out = []
    for folder in filter(None, os.environ.get(PATH_VARIABLE, "").split(os.pathsep)):
        for path in sorted(Path(folder).glob("*.py")):
            name = f"tessera_plugin_{path.stem}"
            spec = importlib.util.spec_from_file_location(name, path)
            module = importlib.util.module_from_spec(spec)
            sys.modules[name] = module
            try:
                spec.loader.exec_module(module)
            except Exception as e:  # noqa: BLE001 - a broken plugin must not take the others with it
                warnings.warn(f"Plugin {path} cannot be loaded: {e}", stacklevel=2)
                continue
            out += [(str(path), n, k) for n, k in vars(module).items() if _is_step(k) and k.__module__ == name]
    return out


def _from_entry_points() -> list[tuple[str, str, type]]:
    out = []
    for point in importlib.metadata.entry_points(group=GROUP):
        try:
            loaded = point.load()
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"Plugin {point.name} cannot be loaded: {e}", stacklevel=2)
            continue
        kinds = [loaded] if _is_step(loaded) else [k for k in vars(loaded).values() if _is_step(k)]
        out += [(f"entry point {point.name}", k.__name__, k) for k in kinds]
    return out


def discover(reload: bool = False) -> dict[str, tuple[str, type]]:
    """Name -> (origin, class). Files win over entry points; of two with one name the first stays, with a warning."""
    global _found
    if _found is None or reload:
        found: dict[str, tuple[str, type]] = {}
        for origin, name, kind in [*_from_files(), *_from_entry_points()]:
            if name in found:
                warnings.warn(f"Plugin '{name}' of {origin} is hidden by that of {found[name][0]}", stacklevel=2)
            else:
                found[name] = origin, kind
        _found = found
    return _found


def find(name: str, module: str | None = None) -> type:
    """A step class by name: from its module, else from the plugins, else from all known subclasses."""
    if module and module.startswith("tessera_plugin_") and name in discover():
        return discover()[name][1]
    if module:
        try:
            return load_class(module, name)
        except (ImportError, AttributeError):
            pass
    if name in discover():
        return discover()[name][1]
    for kind in subclasses():
        if kind.__name__ == name and (module is None or kind.__module__ == module):
            return kind
    raise ImportError(f"Step '{name}' of module '{module}' cannot be found")


def listing() -> list[str]:
    """Built-in steps and plugins as text."""
    own = sorted({k.__name__ for k in subclasses() if k.__module__.startswith("tessera.")})
    return [*own, *(f"{name} ({origin})" for name, (origin, _) in sorted(discover().items()))]
