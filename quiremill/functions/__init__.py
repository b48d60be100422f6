"""Part of quiremill; see README.md."""
