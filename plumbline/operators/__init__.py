"""Operators on state tables: belief, graph, verification, decisions, geometry, ledger, inventory."""
