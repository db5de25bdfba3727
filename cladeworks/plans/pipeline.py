"""Analyses given as data: steps name an operator, its inputs and its options; the result is one lazy DataFrame per step.

    spec = [
        {"name": "pairs", "op": "pair_counts", "from": ["characters"]},
        {"name": "d", "op": "kimura2", "from": ["pairs"]},
        {"name": "fixed", "op": "repair", "from": ["d"]},
        {"name": "splits", "op": "neighbor_net", "from": ["fixed"], "options": {"least": 0.0001}},
    ]
    out = run(spec, {"characters": df})

Columns are checked while the plan is built, before any job runs. A specification is plain JSON. :func:`methods` words it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cladeworks.operators import bootstrap, char_distances, characters, components, distances, hierarchy, networks, orphans, reject_lines, sketches, splits, trees


@dataclass(frozen=True)
class Operator:
    run: Callable[..., DataFrame]
    needs: tuple[tuple[str, ...], ...]  # columns of each input
    text: str


CHARS, PAIRS, DIST, SPLITS, TREES = ("taxon", "site", "ch"), ("t1", "t2", "ca", "cb", "w"), ("t1", "t2", "d"), ("mask", "weight"), ("tree_id", "mask", "weight")
REGISTRY: dict[str, Operator] = {}


def register(name: str, run: Callable[..., DataFrame], *needs: tuple[str, ...]) -> None:
    """Adds an operator; the first line of its docstring is its text. Own operators may be registered too."""
    doc = (run.__doc__ or name.replace("_", " ")).strip().splitlines()[0]
    REGISTRY[name] = Operator(run, needs, doc)


for _f in (characters.pair_counts, characters.site_patterns, characters.haplotypes, characters.haplotype_groups, characters.tajima_d, characters.quartet_v_scores, characters.phi_test, characters.site_statistics, characters.characters_filter, char_distances.base_frequency, splits.dna_to_splits):
    register(_f.__name__, _f, CHARS)
for _f in (char_distances.binary_counts, char_distances.hamming, char_distances.p_distance, char_distances.jukes_cantor, char_distances.kimura2, char_distances.felsenstein81, char_distances.felsenstein84, char_distances.tamura_nei93, char_distances.log_det, char_distances.hky85, char_distances.gtr):
    register(_f.__name__, _f, PAIRS)
for _f in (char_distances.dice, char_distances.jaccard, char_distances.gene_sharing, char_distances.gene_content, char_distances.upholt, char_distances.nei_li):
    register(_f.__name__, _f, ("t1", "t2", "a", "b", "c"))
for _f in (char_distances.repair, distances.delta_scores, distances.four_point_violations, distances.centred, distances.min_spanning_network, distances.min_spanning_tree, distances.min_spanning_rooted, distances.tree_splits_of, distances.upgma, distances.neighbor_joining, distances.neighbor_net, distances.neighbor_net_cycle, distances.split_decomposition, distances.buneman_tree, distances.pcoa):
    register(_f.__name__, _f, DIST)
for _f in (splits.weight_slider, splits.missing_trivial, splits.blob_filter, splits.incompatible_pairs, splits.splits_to_distances, splits.phylogenetic_diversity, splits.shapley_values, splits.cyclic, splits.classify, splits.greedy_compatible, splits.greedy_weakly_compatible, splits.greedy_circular, splits.dimension_filter, splits.incompatibility_score, splits.splits_taxa_filter, splits.clique_compatible, splits.clique_circular, splits.closest_tree, splits.filtered, splits.splits_cycle, networks.cluster_tree, networks.cluster_network, networks.outline, networks.equal_angle):
    register(_f.__name__, _f, SPLITS)
register("fits", splits.fits, SPLITS, DIST)
for _f in (trees.tree_splits, trees.consensus_splits, trees.consensus_clusters, trees.robinson_foulds, trees.average_distances, trees.fair_proportions, trees.equal_splits, trees.tree_diversity, trees.unique_topologies, trees.tree_statistics, trees.trees_filter, trees.edges_filter, trees.tree_selector, trees.conflicts, trees.concordance_filter, trees.confidence_network, trees.transfer_support, trees.rooted_triples, trees.one_spr_pairs, trees.hasse_covers, trees.sample_trees, trees.consensus_outline, trees.triple_contraction):
    register(_f.__name__, _f, TREES[:2])
for _f in (networks.lsa_trees, networks.blob_trees, networks.normalized, networks.contained_trees, networks.classes, networks.class_filter, networks.rerooted, networks.midpoint_rooted, networks.reordered, networks.tree_clusters):
    register(_f.__name__, _f, ("net_id", "parent", "child", "weight", "taxon"))
register("mash_distances", sketches.mash_distances, ("genome", "seq"))
register("sketch", sketches.sketch, ("genome", "seq"))
register("bootstrap_draws", bootstrap.draws, ("site",))
register("split_support", bootstrap.split_support, ("site", "mask"), ("rep", "site", "times"))
for _f in (networks.stretch_filter, networks.simplify, distances.path_distances):
    register(_f.__name__, _f, ("src", "dst", "weight"))
register("check_distances", distances.check_distances, ("src", "dst", "weight"), DIST)
register("loose_and_lacy", networks.loose_and_lacy, ("net_id", "parent", "child", "weight", "taxon"), ("taxon", "trait"))
register("haplotype_traits", characters.haplotype_traits, ("taxon", "haplotype"), ("taxon", "trait", "value"))
register("components", components.components, ("a", "b"))
register("build_hierarchy", hierarchy.build_hierarchy, ("node", "parent"))
register("find_cycles", hierarchy.find_cycles, ("node", "parent"))
register("parse_lines", reject_lines.parse_lines, ("line_id", "feed", "line"))
register("check_references", orphans.check_references, ("ref_table", "ref_id", "at"), ("taxon_id", "loaded_at", "deleted_at"))


class PipelineError(ValueError):
    pass


def run(spec: list[dict] | str, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The DataFrame of every input and step by name. ``spec`` may be JSON text."""
    steps = json.loads(spec) if isinstance(spec, str) else spec
    made = dict(inputs)
    for step in steps:
        name, op = step.get("name"), REGISTRY.get(step.get("op"))
        if op is None:
            raise PipelineError(f"step {name}: no operator {step.get('op')}")
        if not name or name in made:
            raise PipelineError(f"step {name}: a new name is needed")
        sources = step.get("from", [])
        if len(sources) != len(op.needs):
            raise PipelineError(f"step {name}: {len(op.needs)} inputs wanted, {len(sources)} given")
        for s, needs in zip(sources, op.needs):
            if s not in made:
                raise PipelineError(f"step {name}: no input {s}")
            if lost := [c for c in needs if c not in made[s].columns]:
                raise PipelineError(f"step {name}: {s} lacks {', '.join(lost)}")
        try:
            made[name] = op.run(*(made[s] for s in sources), **step.get("options", {}))
        except TypeError as e:
            raise PipelineError(f"step {name}: {e}") from e
    return made


def methods(spec: list[dict] | str) -> str:
    """The analysis in words, a line for each step."""
    steps = json.loads(spec) if isinstance(spec, str) else spec
    lines = []
    for s in steps:
        options = ", ".join(f"{k} = {v}" for k, v in sorted(s.get("options", {}).items()))
        lines.append(f"{s['name']}: {s['op']} of {', '.join(s.get('from', []))}" + (f" ({options})" if options else "") + f". {REGISTRY[s['op']].text}")
    return "\n".join(lines)
