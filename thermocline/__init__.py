"""Tiered vector analytics as Spark DataFrame jobs.

Documents get a temperature from a query workload, are split into hot / warm /
cold tiers, and are searched by a tier-by-tier cascaded top-k.
"""
