"""Extensions: what a plugin may be and do, and the hooks that it can listen to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

# Known capabilities; permissions, all denied unless granted.
CAPABILITIES = ("parser", "exporter", "validator", "reporter", "inference", "gui_panel", "cli_command")
PERMISSIONS = ("filesystem_read", "filesystem_write", "network", "subprocess")
API_VERSION = 1


@dataclass(frozen=True)
class Metadata:
    name: str
    version: str
    api_version: int = API_VERSION
    capabilities: tuple[str, ...] = ()
    author: str = ""


def permissions(granted: dict[str, object] | None = None) -> dict[str, bool]:
    """All permissions: those granted, the known rest denied."""
    return dict.fromkeys(PERMISSIONS, False) | {k: bool(v) for k, v in (granted or {}).items()}


@dataclass
class Context:
    """What a plugin is given when it is switched on."""

    project: object = None
    services: dict[str, object] = field(default_factory=dict)
    permissions: dict[str, bool] = field(default_factory=permissions)


class Plugin:
    """To be derived from: metadata, and what happens on and off."""

    metadata: Metadata | None = None

    def activate(self, context: Context) -> None:
        return None

    def deactivate(self, context: Context) -> None:
        return None


def problems(plugin: object) -> list[str]:
    """Codes of what is wrong with a plugin's metadata."""
    about = getattr(plugin, "metadata", None)
    if about is None:
        return ["PLUGIN_METADATA_MISSING"]
    found = ["PLUGIN_NAME_EMPTY"] * (not about.name.strip()) + ["PLUGIN_API_VERSION_UNSUPPORTED"] * (about.api_version != API_VERSION)
    return found + ["PLUGIN_UNKNOWN_CAPABILITY"] * any(c not in CAPABILITIES for c in about.capabilities)


class Registry:
    """Plugins by name; they are switched on in order of name and off in reverse."""

    def __init__(self) -> None:
        self._plugins: dict[str, Plugin] = {}

    def add(self, plugin: Plugin) -> None:
        about = getattr(plugin, "metadata", None)
        if about is None:
            raise ValueError("plugin metadata required")
        if about.name in self._plugins:
            raise ValueError(f"duplicate plugin {about.name}")
        self._plugins[about.name] = plugin

    def names(self) -> list[str]:
        return sorted(self._plugins)

    def get(self, name: str) -> Plugin:
        return self._plugins[name]

    def able_to(self, capability: str) -> list[Plugin]:
        return [p for p in map(self.get, self.names()) if capability in p.metadata.capabilities]

    def activate(self, context: Context) -> list[str]:
        for name in self.names():
            self._plugins[name].activate(context)
        return self.names()

    def deactivate(self, context: Context) -> list[str]:
        order = self.names()[::-1]
        for name in order:
            self._plugins[name].deactivate(context)
        return order


class Hooks:
    """Callbacks by event name, called in the order they came."""

    def __init__(self) -> None:
        self._calls: dict[str, list[Callable[..., object]]] = {}

    def subscribe(self, name: str, callback: Callable[..., object]) -> None:
        self._calls.setdefault(str(name), []).append(callback)

    def emit(self, name: str, *args: object, **kwargs: object) -> list[object]:
        return [call(*args, **kwargs) for call in list(self._calls.get(str(name), []))]
