"""Registered queries. Each module has QUERIES (Spark) and ORACLES (SQL text) by name."""

from cadenza.plans import catalog_plans, job_plans, link_plans, search_plans

PLAN_MODULES = (catalog_plans, search_plans, link_plans, job_plans)
