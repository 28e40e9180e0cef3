"""Schemas of the trace tables, as DDL (all columns nullable)."""

from __future__ import annotations

RESOURCES = "STRUCT<cpus: FLOAT, memory: FLOAT>"
MACHINE_EVENTS = f"time BIGINT, machine_id BIGINT, type INT, switch_id STRING, capacity {RESOURCES}, platform_id STRING, missing_data_reason INT"
MACHINE_ATTRIBUTES = "time BIGINT, machine_id BIGINT, name STRING, value STRING, deleted BOOLEAN"
COLLECTION_EVENTS = (
    "time BIGINT, type INT, collection_id BIGINT, scheduling_class INT, missing_type INT, collection_type INT, priority INT, alloc_collection_id BIGINT, user STRING, collection_name STRING, "
    "collection_logical_name STRING, parent_collection_id BIGINT, start_after_collection_ids ARRAY<BIGINT>, max_per_machine INT, max_per_switch INT, vertical_scaling INT, scheduler INT"
)
INSTANCE_EVENTS = (
    "time BIGINT, type INT, collection_id BIGINT, scheduling_class INT, missing_type INT, collection_type INT, priority INT, alloc_collection_id BIGINT, instance_index INT, machine_id BIGINT, "
    f"alloc_instance_index INT, resource_request {RESOURCES}, constraint ARRAY<STRUCT<name: STRING, value: STRING, relation: INT>>"
)
INSTANCE_USAGE = (
    "start_time BIGINT, end_time BIGINT, collection_id BIGINT, instance_index INT, machine_id BIGINT, alloc_collection_id BIGINT, alloc_instance_index BIGINT, collection_type INT, "
    f"average_usage {RESOURCES}, maximum_usage {RESOURCES}, random_sample_usage {RESOURCES}, assigned_memory FLOAT, page_cache_memory FLOAT, cycles_per_instruction FLOAT, "
    "memory_accesses_per_instruction FLOAT, sample_rate FLOAT, cpu_usage_distribution ARRAY<FLOAT>, tail_cpu_usage_distribution ARRAY<FLOAT>"
)
POWER = "time BIGINT, cell STRING, pdu STRING, measured_power_util DOUBLE, production_power_util DOUBLE, bad_measurement_data BOOLEAN, bad_production_power_data BOOLEAN"
MACHINE_TO_PDU = "machine_id BIGINT, pdu STRING, cell STRING"
LEGACY_TASKS = "Time INT, JobID BIGINT, TaskID BIGINT, JobType INT, NrmlTaskCores DOUBLE, NrmlTaskMem DOUBLE"
TABLES = {
    "machine_events": MACHINE_EVENTS, "machine_attributes": MACHINE_ATTRIBUTES, "collection_events": COLLECTION_EVENTS, "instance_events": INSTANCE_EVENTS,
    "instance_usage": INSTANCE_USAGE, "power": POWER, "machine_to_pdu_mapping": MACHINE_TO_PDU,
}
