"""Tables of files, imports and packages: from source trees and from the given tables."""
