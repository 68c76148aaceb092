"""The daily roll-up kept up to date as observation files arrive."""
