"""Query trees and their compilation to columns."""
