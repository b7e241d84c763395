"""Scoped analytics by workstream. `scoped` is always the result of `scope.scope_cases`."""
