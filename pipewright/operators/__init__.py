"""DataFrame operators: spatial joins, interval sweeps, forests, skylines, rules, selection."""
