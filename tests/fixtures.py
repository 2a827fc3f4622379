"""A small graph of eight entities, its edges, capabilities and usages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENTITIES = (
    "entity_id string, name string, qualified_name string, signature string, kind string, file_path string, body_start_line int, body_end_line int, "
    "definition_text string, source_text string, brief string, details string, params map<string,string>, returns string, notes string, rationale string, "
    "usages map<string,string>, capability string, is_entry_point boolean, fan_in int, fan_out int, is_contract_seed boolean, doc_embedding array<double>, symbol_embedding array<double>"
)


def entities(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    from quillgraph.functions.scalars import symbol_searchable

    def row(i, name, scope, sig, kind, cap, entry=False, fi=0, fo=0, brief=None, path="a.cc", **more):
        return (
            i, name, f"{scope}::{name}" if scope else name, sig, kind, path, more.get("start"), more.get("end"), f"{sig};", more.get("source"), brief, more.get("details"),
            more.get("params"), more.get("returns"), more.get("notes"), more.get("rationale"), more.get("usages"), cap, entry, fi, fo, more.get("seed", False), more.get("vec"), more.get("vec"),
        )

    rows = [
        row("fn:a1b2c3d", "damage", "Combat", "int damage(Character *ch, int amount)", "function", "combat", fi=23, fo=8, brief="Applies damage to a character", details="Handles armor and death", params={"ch": "the victim", "amount": "hit points"},
            returns="the damage dealt", notes="not reentrant", rationale="central contract of combat", seed=True, start=2, end=4, source="int damage() {}", vec=[1.0, 0.0], usages={"fight_8cc, void hit()": "deals damage", "spell_8cc, void bolt(int a, int b)": "spell damage", "odd": "no comma"}),
        row("fn:b2c3d4e", "do_kill", "", "void do_kill(Character *ch, char *arg)", "function", "commands", True, 1, 15, "Starts a fight", vec=[0.6, 0.8]),
        row("cls:c3d4e5f", "Character", "", "class Character", "class", "character_state", brief="A being in the world", vec=[0.0, 1.0]),
        row("var:d4e5f6a", "max_damage", "", "int max_damage", "variable", "combat", fi=5, vec=[0.0, 0.0]),
        row("fn:e5f6a7b", "armor_absorb", "Combat", "int armor_absorb(int amount)", "function", "combat", fi=10, fo=2, brief="Reduces damage by armor"),
        row("file:f6a7b8c", "fight.cc", "", "fight.cc", "file", "combat"),
        row("file:a7b8c9d", "Character.hh", "", "Character.hh", "file", "character_state"),
        row("fn:h8i9j0k", "damage", "Logging", "void damage(const char *msg)", "function", "logging", fi=2, fo=1, brief="Logs damage messages"),
    ]
    return spark.createDataFrame(rows, ENTITIES).withColumn("symbol_searchable", symbol_searchable(F.col("name"), F.col("qualified_name"), F.col("signature")))


def edges(spark: SparkSession) -> DataFrame:
    rows = [
        ("fn:b2c3d4e", "fn:a1b2c3d", "calls"), ("fn:a1b2c3d", "fn:e5f6a7b", "calls"), ("fn:a1b2c3d", "var:d4e5f6a", "uses"),
        ("file:f6a7b8c", "file:a7b8c9d", "includes"), ("cls:c3d4e5f", "file:a7b8c9d", "inherits"),
    ]
    return spark.createDataFrame(rows, "src string, dst string, relationship string")


def call_graph(spark: SparkSession) -> DataFrame:
    calls = [("main", "do_kill"), ("do_kill", "damage"), ("do_kill", "do_look"), ("damage", "send_to_char"), ("damage", "affect_to_char"), ("do_look", "show_room_to_char")]
    rows = [(a, b, "calls") for a, b in calls] + [("damage", "global_dam_stat", "uses"), ("Player", "Character", "inherits"), ("MobilePrototype", "Character", "inherits")]
    return spark.createDataFrame(rows, "src string, dst string, relationship string")
