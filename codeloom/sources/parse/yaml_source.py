"""Kubernetes objects and Crossplane types of YAML files."""

from __future__ import annotations

import yaml

from .base import Source


def plain(node: yaml.Node) -> object:
    """A document as dicts, lists and text; every scalar is text, an empty one None."""
    if isinstance(node, yaml.MappingNode):
        return {k.value: plain(v) for k, v in node.value if isinstance(k, yaml.ScalarNode)}
    if isinstance(node, yaml.SequenceNode):
        return [plain(v) for v in node.value]
    return None if node.value == "" and node.style is None else node.value


def _dict(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _dicts(value: object) -> list[dict]:
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


def _crossplane(source: Source, owner: str, kind: str, api: str, spec: dict, span: tuple[int, int, int, int]) -> None:
    def link(id_: str, name: str, type_: str, relation: str, **metadata: object) -> None:
        source.symbol(id_, name, type_, span, **metadata)
        source.relate(owner, id_, relation, span, evidence=1.0, columns=False)

    if kind == "CompositeResourceDefinition":
        group, made = spec.get("group") or api.split("/")[0], _dict(spec.get("names")).get("kind")
        if made and group:
            link(f"xrdtype:{group}:{made}", made, "resource_type", "DEFINES", group=group, kind=made, scope=spec.get("scope"), claimNames=_dict(spec.get("claimNames")).get("kind"))
    elif kind == "Composition":
        ref = _dict(spec.get("compositeTypeRef"))
        if ref.get("apiVersion") and ref.get("kind"):
            group = ref["apiVersion"].split("/")[0]
            link(f"xrdtype:{group}:{ref['kind']}", ref["kind"], "resource_type", "COMPOSITES", group=group, kind=ref["kind"])
        for step in _dicts(spec.get("pipeline")):
            if name := _dict(step.get("functionRef")).get("name"):
                link(f"fn:{name}", name, "module", "USES", kind="Function")
        for entry in _dicts(spec.get("resources")):
            base = _dict(entry.get("base"))
            if made := base.get("kind"):
                version = base.get("apiVersion")
                link(f"mrtype:{version}:{made}" if version else f"mrtype:{made}", made, "resource_type", "CREATES", kind=made, apiVersion=version)


def parse_yaml(source: Source, strict: bool = False) -> None:
    """Fill in a YAML file's objects, of every document in it; bad YAML raises YAMLError.

    A part that should be a mapping but is empty counts as absent, so the object is kept.
    """
    text = source.data.decode("utf-8", "replace")
    for node in yaml.compose_all(text, Loader=yaml.BaseLoader):
        value = plain(node)
        api, kind = _dict(value).get("apiVersion"), _dict(value).get("kind")
        if not isinstance(api, str) or not isinstance(kind, str):
            continue
        name = _dict(value.get("metadata")).get("name") or "unknown"
        start, end = node.start_mark, node.end_mark
        span = (start.line + 1, start.column, end.line + 1, end.column)
        id_ = source.symbol(source.id(f"k8s:{kind}:{name}"), name, "resource", span, kind=kind, apiVersion=api)
        source.relate(source.file, id_, "KUBERNETES_OBJECT", span, columns=False)
        _crossplane(source, id_, kind, api, _dict(value.get("spec")), span)
