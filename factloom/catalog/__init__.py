"""Registered queries, by kind; importing a module registers its queries."""
