"""Schemas of knowledge objects and of what is derived from them."""

RELATIONS = "array<struct<type:string,target:string,soft_link:boolean,created_date:string>>"
OBJECT = (
    "path string, id string, title string, schema_version string, aliases array<string>, keywords array<string>, scope string, "
    "taxonomy_path string, taxonomy_id string, object_type string, domain string, toolchain array<string>, prog_language array<string>, "
    "language array<string>, audience string, architecture array<string>, lifecycle string, test_level array<string>, evidence string, "
    "verification string, authority string, consensus string, source_type string, source_refs array<string>, author string, "
    "last_modified string, reviewer string, last_verified string, next_review string, confidence string, "
    f"validity struct<valid_from:string,valid_until:string>, status string, relations {RELATIONS}, "
    "unknown_fields array<string>, raw_body string, load_error string"
)
FINDING = "code string, field string, file string, level string"
CODE_NODE = "node_id string, kind string, name string, path string, line int"
CODE_EDGE = "src string, dst string, type string, path string"
